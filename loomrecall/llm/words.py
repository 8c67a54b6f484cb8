"""Given names, which tell names of people from other capitalized words and give surrogates their gender."""

from __future__ import annotations

#: Given names of women and men (a word list; more can be passed to the operators).
FEMALE = frozenset("ágnes agnes alina amelie ana anastasia anja anna anneke aisha astrid aylin beatriz birgit camille carla carmen caroline catarina céline chiara chloé claire daniela edda elena elif elise elizabeth emily emma eva fatima fatou francesca frida gabriela giulia greta hana hannah heidi helena ingrid ines irina isabel jana jasmin jennifer jessica johanna julia karin katarina katya laura leila lena linda lucia madeleine maëlle margarita maria marisa marta mei mina mirela monika nadia natalia ngozi nina noor olga ottilie patricia paula petra pilar priya rebecca rosa ruth samira sarah selma sofia stella susanne svetlana tamsin tatiana valentina vera wanda ximena yasmin yuna abigail adele aaliyah aditi alejandra alessia amanda amara amina amy anastasiya andrea angela angelina anita ann annabelle antonia ariana asha ashley astou ayaka ayesha barbara bianca brenda brigitte carol carolina catherine cecilia charlotte chioma christina christine cynthia debra deepika denise diana dilnoza dorothy ebony edith eleanor elisabeth ella erica esther eugenia evelyn ewa farah fatma felicia fiona florence françoise gabriela genevieve gertrude giovanna gwendolyn hanako harriet hye-jin ikram ilse imani ines ingeborg isabella isabelle ivana jacqueline jane janet jeanne jelena joanna josephine joyce judith juliana julie kamala kateryna katherine kathleen katja kavita keiko keisha kimberly kirsten kristina ksenia lakshmi larissa latoya lauren leticia liliana linnea lisa louise luciana ludmila lyudmila magdalena maja malika manuela margaret marianne marina marjorie martha martina mary matilda meera megan mei-ling melanie melissa mercedes michelle milena miriam monica mónica nancy naomi natalie nicole nisha noelia noémie noriko oksana olivia pamela parvati pauline penelope philippa pooja priyanka rachel raquel renata rosalind roxana rukhsana sakura sandra sanjana shanice sharon shreya silvia sinead siobhan sonia sophia sophie stephanie sumiko susan svenja tamara tanya teresa theresa ulrike ursula valeria vanessa veronica veronika victoria virginia vivian wangari xiu yekaterina yolanda yoko yvonne zahra zainab zeynep zuzana zofia zoë ελένη μαρία олеся анна мария ольга елена".split())
MALE = frozenset("abdul ahmed alejandro aleksander andreas anton antonio arjun bjarne boris bruno carlos christian christopher daniel dario darius david diego dimitri dmitri edward emeka emil enrique erik farid felix fernando francesco friedrich georg giovanni gustav hans hassan heinrich henrik hiroshi hugo ibrahim igor ivan ivor jakob jamal jan javier jens joão jonas jonathan jorge josef juan karl kenji khalid klaus kofi kwame lars leopold liam lorenzo luca lukas mateo matthias mehmet michael mikhail mohammed nikolai omar oskar otto pablo pavel pedro pierre quentin rafael raj ravi robert roberto samuel sergei stefan sven søren thiago thomas tomas ulrik viktor vladimir wei werner wilhelm wim yusuf adam adebayo adrian aiden akira alan albert alberto alessandro alexander alexei alfonso alfred ali amit anders andrea andré andrew andrzej angelo anil anthony antoine armando arnold artem arthur arturo ashok augustin aurelio barack bartholomew benedict benjamin bernard bernd bilal björn boubacar brandon brian carl cedric cheng chidi christoph claude-henri clement colin connor craig cristian cyril damian damien darnell deshawn derek diarmuid dieter dmytro dominic donald douglas dragan eduardo edgar edmund efraín eino elias elijah elliott emmanuel enzo eric ernest ernesto esteban étienne eugene ewan fabian faisal federico fergus feng finn florian francis francisco franz frederick fritz gareth gary geoffrey george gerald gerard gerhard giorgio giuseppe gonzalo graham gregory guillaume gunther günter gustavo hamza haruto hector heinz helmut henri henry herbert hernán hidetoshi hiroto horst howard hubert imran isaac jaime jamie jared jason javed jeffrey jeremy jérôme joachim joel johann johannes john jorge-luis joseph joshua julian julio jürgen kamal kareem kazuo keith kenneth kevin kieran kiran kunal kurt kwabena kyle lamar laurent lawrence leandro leonard leonardo lionel lloyd louis lucas ludwig luigi luis malcolm malik manfred manoj manuel marcel marcelo marco marcos mario markus martin massimo matthew matteo maurice maximilian maxim miguel mihai mikael mikko milan mustafa nathan nathaniel neil nelson nicholas nicola nigel nikhil nikolay nnamdi norbert oliver olivier olumide omar-said orlando oswald owen patrick patrício paul paulo percival peter philip philippe piotr pranav radoslav rafał rainer rajesh ralph ramesh ramón randall rashid raymond reinhard ricardo richard roland rolf ronald rory ruben rudolf rupert salvador sanjay santiago sanjeev saul scott sean sebastian sebastián sergio seung-ho simon sipho stanislav stephen steven stuart sunil sven-olof takashi takeshi tariq terence theodore thibault thorsten tim timothy tobias todd tomás tomasz tyrone ubaldo uwe vadim valentin viktoras vincent vinod volodymyr walter wayne werner-karl william winston wolfgang xavier yannick yevgeny yukio yuri zachary zbigniew νίκος γιώργος мирослав иван дмитрий сергей александр".split())
GIVEN = FEMALE | MALE
